"""Training-data operators: quality, deduplication, PII, URL filters, search,
mixing, sharding and tokenisation. Nothing else in ``logscope`` imports this
subpackage."""
