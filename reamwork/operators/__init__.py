from . import blocks, config, ocr, ordered, records, reports, sequence, tables  # noqa: F401
