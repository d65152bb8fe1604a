"""topicscope: topic analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver except bounded model state (vocabulary lists,
k x V topic matrices) that spark.ml itself keeps on the driver.
"""

__version__ = "0.1.0"
