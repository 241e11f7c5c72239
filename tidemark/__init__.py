"""tidemark: incremental message triage as Spark DataFrame jobs.

Sub-packages:
  functions/  pure Column expressions (fingerprint, text, dates, html, results, render)
  sources/    readers: driver tables, fixture views, incremental source, store, .eml job
  operators/  DataFrame -> DataFrame building blocks (ids, cache, enrichment, pacing, latest)
  sinks/      table writes (store append, cursors, audit, cache) and batch sinks
  plans/      composed jobs: run plan, ingest, query, status, reports
  streaming/  run-once Structured Streaming wrapper around the ingest job
"""

__all__ = ["constants", "schemas", "session"]
