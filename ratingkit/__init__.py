"""ratingkit: rating-prediction feature engineering and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
