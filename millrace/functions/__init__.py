"""functions of the engine; every public function maps DataFrames or Columns to the same."""
