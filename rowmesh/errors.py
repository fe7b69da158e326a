"""Errors of the engine. All shape and bound errors are raised on the driver, before a plan is built."""


class MatrixError(Exception):
    pass


class DimensionError(MatrixError):
    def __init__(self) -> None:
        super().__init__("number of dimensions must be greater than zero")


class ShapeMismatch(MatrixError):
    def __init__(self) -> None:
        super().__init__("matrices must have identical dimensions")


class ProductMismatch(MatrixError):
    def __init__(self) -> None:
        super().__init__("LHS cols() != RHS rows()")


class MatrixIndexError(MatrixError, IndexError):
    def __init__(self) -> None:
        super().__init__("values are not in bounds")


class NanNormError(MatrixError):
    def __init__(self) -> None:
        super().__init__("a row sum is not a number")


class MatrixMarketError(MatrixError):
    pass


class ZeroDimensionError(MatrixMarketError):
    def __init__(self) -> None:
        super().__init__("a matrix must have at least one row and one column")


class TupleTextError(MatrixError):
    pass
