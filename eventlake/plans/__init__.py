"""The engine's queries over fixture tables, each with the SQL that a reference database answers alike."""
