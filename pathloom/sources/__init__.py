"""Where graphs come from: tables mapped from any Spark source, and graphs that the library stores itself."""
