"""The analysis operators: profiling, cleaning, RFM, products, customers, segments, models."""
