"""Column functions over bound maps and status flags."""
