"""Training-data operators: decontamination, deduplication, filters, mixing and token output.

Nothing outside this subpackage imports it; its queries are added by the driver contract
only when it is present.
"""
