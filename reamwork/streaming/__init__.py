from .landing import (  # noqa: F401
    as_they_are, block_converter, compact, json_lines_converter, latest_records, stream_convert, stream_files, watch_binary, watch_csv,
    watch_packed, watch_text, workbook_converter,
)
