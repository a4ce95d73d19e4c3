"""The order, line-item and event tables read as claims data, for tests and checks."""
