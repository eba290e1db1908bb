"""Part of gatewarden."""
