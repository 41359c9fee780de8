"""Reading tables and writing them in other formats."""
