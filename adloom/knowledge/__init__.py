"""Static, bounded knowledge: categories, rules, plans and templates."""
