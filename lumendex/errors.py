"""What the engine raises."""


class Error(Exception):
    """The base of the engine's own errors; failures of files and jobs come through as they are."""


class Corrupt(Error):
    def __init__(self, message: str):
        super().__init__(f"corrupt database: {message}")


class InvalidInput(Error):
    def __init__(self, message: str):
        super().__init__(f"invalid input: {message}")


class TransactionClosed(Error):
    def __init__(self):
        super().__init__("transaction is already closed")
