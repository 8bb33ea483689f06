"""Column expressions shared by every operator. None of them runs Python per row."""
