"""Column expressions; every one stays inside the JVM unless its docstring says otherwise."""
