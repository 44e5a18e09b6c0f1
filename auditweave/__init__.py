"""Cloud audit-log analytics as plain DataFrame-to-DataFrame functions.

Subpackages
-----------
functions  column expressions (IP addresses, user agents, severities, variants)
sources    readers and writers
operators  the analytics themselves
plans      test-table adapter, registered queries and their SQL counterparts
streaming  Structured Streaming versions
"""

__version__ = "0.1.0"
