"""terravox: point-cloud analytics and corpus preparation on PySpark DataFrames."""
