"""Relational operators: rule bodies as joins, and fixed points over them."""
