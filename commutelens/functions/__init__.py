"""Column functions: clock arithmetic, JSON, geography, money and text. Column in, Column out."""
