"""Plans that join operators."""
