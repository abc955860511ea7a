"""Point-in-time operators over DataFrames."""
