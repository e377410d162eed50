"""The registry model on the star-schema tables, the registered queries and their SQL."""
