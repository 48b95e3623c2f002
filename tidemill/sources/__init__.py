"""Reading tables and inferring their types."""
