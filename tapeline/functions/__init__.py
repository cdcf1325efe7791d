from . import finance, hashing, numeric, scoring, text, times  # noqa: F401
