"""Reading and writing of flow tables, reports and models."""
