from dendra.functions import text, vectors  # noqa: F401
