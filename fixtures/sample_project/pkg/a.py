"""Shapes of code that extraction has to tell apart."""


class Box:
    """A box with a value."""

    size = 1
    depth: int = 2
    wide, tall = 3, 4

    def __init__(self, value):
        """Keep the value."""
        self.value = value

    def doubled(self):
        twice = self.value * 2
        return twice

    class Inner:
        def deep(self):
            return 1


def helper(x):
    """Helps."""
    def nested(y):
        return y
    return nested(x)


@staticmethod
def decorated(
    a: int,
    b: int,
) -> int:
    return a + b


async def later():
    return helper(1)
