"""Column functions: Column -> Column, no jobs, no UDFs."""
