"""Fixed values of the rules, in one place."""

CHUNK_LINES, CHUNK_BYTES = 20, 2048
BM25_K1, BM25_B = 1.2, 0.75
PAGE_ROWS, SPAN_BYTES, BATCH_BYTES = 20, 4096, 65536
SPANS, PER_PATH, CLAIMS = 8, 2, 4
ROLLING_SECONDS = 18000
INDEX_VERSION = "lodestone-index-1"
