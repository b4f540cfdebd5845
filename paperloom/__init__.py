"""PySpark-native document analytics: layout, tables, text and conversion jobs as DataFrame operators."""
