"""Declared schemas and column names of the two inputs.

Raw transaction lines keep the numeric columns as text (they are coerced by
``coerce_numeric``); the typed view is what cleaning produces.
"""

from pyspark.sql import types as T

# Column names of the transaction table (one row per invoice line).
INVOICE = "InvoiceNo"
STOCK = "StockCode"
DESCRIPTION = "Description"
QUANTITY = "Quantity"
INVOICE_DATE = "InvoiceDate"
UNIT_PRICE = "UnitPrice"
CUSTOMER = "CustomerID"
COUNTRY = "Country"
TOTAL_PRICE = "TotalPrice"

TX_COLUMNS = [INVOICE, STOCK, DESCRIPTION, QUANTITY, INVOICE_DATE, UNIT_PRICE,
              CUSTOMER, COUNTRY, TOTAL_PRICE]

# Raw lines as they arrive: dirty numerics are text, the id may be fractional.
RAW_TX_SCHEMA = T.StructType([
    T.StructField(INVOICE, T.StringType()),
    T.StructField(STOCK, T.StringType()),
    T.StructField(DESCRIPTION, T.StringType()),
    T.StructField(QUANTITY, T.StringType()),
    T.StructField(INVOICE_DATE, T.TimestampNTZType()),
    T.StructField(UNIT_PRICE, T.StringType()),
    T.StructField(CUSTOMER, T.DoubleType()),
    T.StructField(COUNTRY, T.StringType()),
    T.StructField(TOTAL_PRICE, T.DoubleType()),
])

# Lines after coercion and id conversion.
TX_SCHEMA = T.StructType([
    T.StructField(INVOICE, T.StringType()),
    T.StructField(STOCK, T.StringType()),
    T.StructField(DESCRIPTION, T.StringType()),
    T.StructField(QUANTITY, T.DoubleType()),
    T.StructField(INVOICE_DATE, T.TimestampNTZType()),
    T.StructField(UNIT_PRICE, T.DoubleType()),
    T.StructField(CUSTOMER, T.LongType()),
    T.StructField(COUNTRY, T.StringType()),
    T.StructField(TOTAL_PRICE, T.DoubleType()),
])

# Customer table columns.
RECENCY = "Recency"
FREQUENCY = "Frequency"
MONETARY = "Monetary"
R_SCORE = "R_score"
F_SCORE = "F_score"
M_SCORE = "M_score"
RFM_SCORE = "RFM_Score"
SEGMENT = "Segment"
CHURN = "Churn"
CLV = "CLV"

RFM_SCHEMA = T.StructType([
    T.StructField(CUSTOMER, T.LongType()),
    T.StructField(RECENCY, T.IntegerType()),
    T.StructField(FREQUENCY, T.IntegerType()),
    T.StructField(MONETARY, T.DoubleType()),
    T.StructField(R_SCORE, T.IntegerType()),
    T.StructField(F_SCORE, T.IntegerType()),
    T.StructField(M_SCORE, T.IntegerType()),
    T.StructField(RFM_SCORE, T.IntegerType()),
    T.StructField(SEGMENT, T.StringType()),
])

# Product table columns.
TOTAL_QUANTITY = "TotalQuantitySold"
TOTAL_REVENUE = "TotalRevenue"

# Columns of folded lines: their number and their money as a decimal.
LINES = "_lines"
MONEY = "_money"

# Feature set of both models (churn and lifetime value).
MODEL_FEATURES = [RECENCY, FREQUENCY, MONETARY, R_SCORE, F_SCORE, M_SCORE, RFM_SCORE]
