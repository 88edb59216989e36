"""Point-cloud operators on DataFrames."""
