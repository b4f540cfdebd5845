"""DataFrame operators on layout, table, OCR and job data."""
