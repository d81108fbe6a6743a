"""Generic DataFrame operators: they take column names and know nothing about PDF."""
