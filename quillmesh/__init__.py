"""quillmesh: corpus-scale note retrieval and concept curation on Spark DataFrames.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing here starts a session, reads a clock or draws a random
number on its own: timestamps and seeds are arguments.
"""

__version__ = "0.1.0"
