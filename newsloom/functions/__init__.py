"""Column functions: Column in, Column out, all of them built-in expressions."""
