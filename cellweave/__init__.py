"""PySpark-native analytics over spatial-molecule tables.

Every operator is a function from DataFrames to a DataFrame; nothing here
collects data that grows with the input to the driver.
"""
