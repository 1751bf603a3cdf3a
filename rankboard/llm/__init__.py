"""Training-data operators: deduplication, decontamination, language ID, scoring, packing, extraction.

Each module holds one operator with its own general interface; ``queries`` holds
the thin ``opN_<name>`` queries over the driver's tables.  Nothing outside this
package imports it.
"""
