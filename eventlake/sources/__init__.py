"""Where records come from: fixture tables, record tables, native segment files."""
