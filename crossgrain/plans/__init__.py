"""The expression language and the registered queries."""
