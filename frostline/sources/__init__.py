"""Tables, catalog, audit log and objects: where rows and bytes come from and go to."""
