"""DataFrame -> DataFrame operators over the reading schema (or any table)."""
