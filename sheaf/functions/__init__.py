"""Column functions: text, numbers, URLs, vehicle identity and photos."""
