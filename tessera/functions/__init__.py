"""Part of the image-container analytics engine."""
