"""linkharbor: publication-link discovery and table quality on Spark DataFrames.

Every operator is a plain function from DataFrames to a DataFrame (or from columns to a column), so
Catalyst sees one declarative plan.  Subpackages:

* ``functions``  column expressions (URL parts, filters, mime, retry, HTML)
* ``operators``  relational operators (profiles, parsing, selection, breakers, eager aggregation)
* ``sources``    readers and writers
* ``streaming``  keyed state on Structured Streaming
* ``plans``      the registered queries and their SQL
"""

__version__ = "0.1.0"
