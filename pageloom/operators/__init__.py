"""DataFrame to DataFrame operators over blocks, pages, tables and layout boxes."""
