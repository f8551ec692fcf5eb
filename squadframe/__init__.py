"""Squad-composition analytics on Spark."""
