"""Training-data operators (document fingerprints, mixing, token counts, ...).

Nothing outside this subpackage imports it; the queries live in :mod:`mortar.llm.queries`.
"""
