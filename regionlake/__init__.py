"""regionlake: document-region analytics as Spark jobs.

Every public function takes and returns DataFrames (or Columns); the library never creates a session.
"""
