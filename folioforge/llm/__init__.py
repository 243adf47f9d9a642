"""Training-data operators: extraction, scans, token files, classifiers, de-duplication, packing.

Nothing outside this subpackage imports it.
"""
