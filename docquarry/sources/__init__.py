"""Reading and writing tables, files and stored pages."""
