from . import binary, markup, names, text  # noqa: F401
