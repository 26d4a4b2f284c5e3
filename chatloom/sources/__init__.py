"""Reading raw records and writing layers."""
