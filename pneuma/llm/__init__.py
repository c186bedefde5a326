"""Training-data operators: token files, BPE, language id, quality rules, dedup, decontamination,
URL lists, SimHash, secret scans, chat formatting, collocations, ranked search and license scans.

Nothing outside this subpackage imports it. Null and repeated rows, empty tables and
extra columns are handled by every operator; each docstring states the result.
"""
