"""Column builders: analysis, n-grams, stemming and SMART weights."""
