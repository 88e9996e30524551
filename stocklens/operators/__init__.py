"""DataFrame operators of the retail analytics contract."""
