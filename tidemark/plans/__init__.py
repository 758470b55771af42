"""Bindings of the operators to tables, the registered queries, and the SQL that checks them."""
