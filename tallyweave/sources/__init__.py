"""Statements, invoices, documents and account charts as DataFrames."""
