"""Relational operators that plans and audits are made of."""
