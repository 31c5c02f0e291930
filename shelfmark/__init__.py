"""Catalogue of files on many storage devices, as Spark jobs.

Every operator is a function from DataFrames and keyword arguments to a DataFrame.  ``sources`` reads listings and
tables, ``operators`` maintains the catalogue, ``plans`` holds the reports, ``streaming`` the continuous forms.
"""
