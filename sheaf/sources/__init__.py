"""Sources: captured pages by manifest, validated record files, spec libraries."""
