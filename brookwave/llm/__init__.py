"""Training-data operators: URL filters, licence scans, language-model scoring,
quality rules, near-duplicate removal, packing, toxicity, quality classifier,
chat formatting and benchmark decontamination.

Nothing else in the library imports this subpackage.
"""
