"""Writers and the documents they write."""
