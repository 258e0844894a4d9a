"""The table store: manifests, transactions, scans."""
