"""All queries of the catalogue by name."""

from keyweave.catalog import batch_queries as batches
from keyweave.catalog import coverage_queries as coverage
from keyweave.catalog import folder_queries as folders
from keyweave.catalog import function_queries as functions
from keyweave.catalog import sync_queries as sync
from keyweave.catalog import table_queries as tables
from keyweave.catalog import term_queries as terms
from keyweave.catalog import update_queries as updates

QUERIES = {
    name: query
    for module in (sync, updates, coverage, terms, tables, batches, folders, functions)
    for name, query in module.QUERIES.items()
}
