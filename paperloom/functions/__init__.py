"""Column functions: cleaning rules, text rules, fixed word lists."""
