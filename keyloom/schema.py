"""Schemas and constants of the versioned key-value model."""

from __future__ import annotations

SET, DELETE = 0, 1
#: The first sequence number of a new table.
FIRST_SEQ = 2
#: The largest sequence number whose packed form keeps its order as a signed 64-bit number.
MAX_SEQ = (1 << 55) - 1
META_BYTES = 8
#: Bytes of keys, metadata and values beyond which a memtable becomes a run.
MEMTABLE_BYTES = 1 << 20
BLOCK_BYTES = 4096
#: Bytes that an entry reserves in a block besides key and value.
ENTRY_RESERVE = 20
#: Bytes at which a compaction begins its next output run.
RUN_BYTES = 4 << 20
LEVELS = 4
L0_RUNS = 2
LEVEL_BASE_BYTES = 128 << 20
LEVEL_GROWTH = 10
CACHE_SECONDS = 3

LOG = "batch_id bigint, ord int, seq bigint, kind tinyint, key binary, value binary"
ENTRY = "key binary, seq bigint, kind tinyint, value binary"
RUN_META = "level int, run_id bigint, n_entries bigint, data_bytes bigint, min_key binary, max_key binary, min_seq bigint, max_seq bigint"
