"""textloom: corpus, link-graph and prompt-packing jobs written as PySpark DataFrame plans.

Layout:
  functions/  column expressions (text, paths, URLs, HTML, code, JSON)
  sources/    table readers, derived views and sinks
  operators/  relational operators (predicates, resolution joins, closures,
              ordered packing, path trees, class structure, snapshots, messages)
  plans/      end-to-end jobs composed from operators (scrape, import collect, review bundle)
  streaming/  Structured Streaming variants
"""

__version__ = "0.1.0"
