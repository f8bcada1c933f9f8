"""What the store raises."""


class DocumentNotFound(LookupError):
    """No document has the id; the message is the one that the API returns with 404."""

    def __init__(self, doc_id: str):
        super().__init__("Document not found")
        self.doc_id = doc_id


class InvalidDocument(ValueError):
    """A body that isn't a JSON object, or has an object where a field's value belongs."""


class InvalidSize(ValueError):
    """A result size below 0 or above the window."""


class InvalidQuery(ValueError):
    """A query with more distinct words than a search takes."""
