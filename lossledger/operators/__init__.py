"""Relational operators: `DataFrame -> DataFrame` steps the plans are composed of."""
