"""Index construction, Boolean and ranked retrieval, feedback, expansion, language models."""
