"""Training-data operators: dedup, tokens, licences, languages, packing, archives, quality and language models.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries.
"""
