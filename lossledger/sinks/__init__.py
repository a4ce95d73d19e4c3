"""Writers: Bronze, dead letters, message topics, tables and reports."""
