"""Sources: PDF, image, code and text files, and their validation."""
