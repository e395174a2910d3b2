"""Column functions: scalars, URLs, text lines, cleaning, and the HTML tree."""
