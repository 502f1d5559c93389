"""Column functions: text, dates, citations, vectors.  All run inside the JVM."""
