"""Writers of reports and price lists."""
