"""Training-data operators: packing, classifiers, deduplication, language id, chat
formatting, byte-level BPE, media columns, host reputation, statistic outliers, periodic runs,
token files and conversation repair."""
